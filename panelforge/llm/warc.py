"""WARC archives: records for pages, and reading them back by boundary-chain verification.

Reading deals byte blocks of the archives to tasks. A task lists every place in its block that looks like the start of a
record, the place where that record would end (its successor), and where the chain from there leaves the block. Chains
are then followed from offset 0 by pointer jumping between blocks, in as many rounds as the logarithm of the blocks of
the largest archive. Only reachable records count, so a record's magic within a payload is rejected wherever blocks begin.

Defined results: a null html is the empty payload. A null page_id is written as such and comes back null. Rows that
repeat the largest page_id of their payload are all responses. Control characters in a url are percent-encoded. A chain
that breaks (a truncated archive) ends there. Extra columns are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingFiles, materialize, new_folder, shared_dir, small_batches, store

#: The format's fixed strings.
MAGIC, END, GAP = b"WARC/1.0\r\n", b"\r\n\r\n", b"\r\n\r\n"
#: What is read beyond a block for the header of its last record; where that ends later, more is read.
USUAL_HEADER = 64 << 10
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: a response).

    Only payloads that occur more than once are joined back; their table is written first, so that Spark broadcasts it
    where its threshold allows and else may split a payload that many rows share."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    again = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    again = materialize(again.filter("n > 1").select("digest", "largest"), "payloads")
    joined = rows.join(again, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def _record(page_id: int | None, url: str, html: bytes, digest: bytes, refers_to: int | None) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http + html if refers_to is None else http
    lines = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + END + block + GAP


def write_archives(records: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes what ``plan_records`` gave to archives in the shared folder; returns their path and size."""
    small_batches(records.sparkSession)
    folder = new_folder(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = RollingFiles(folder, ".warc", archive_bytes), []

        def close() -> None:
            if out.out is not None:
                out.close()
                done.append((out.path, out.size))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                out.append(_record(page_id, url, html.encode(), bytes.fromhex(digest), refers_to))
                if out.full:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "size"])

    return materialize(records.mapInArrow(write, "path string, size long"), "archives")


def _header_end(file, data: bytes, start: int, at: int, size: int) -> tuple[bytes, int]:
    """data (the file's bytes from ``start``), read on until the header at ``at`` ends in it, and that end (-1: it has none).

    No header holds a second MAGIC, as line breaks in a url are encoded; so each byte is searched for one header only."""
    while True:
        other = data.find(MAGIC, at + 1)
        end = data.find(END, at, other if other >= 0 else len(data))
        if end >= 0 or other >= 0 or start + len(data) >= size:
            return data, end
        more = file.read_at(min(size - start - len(data), max(USUAL_HEADER, len(data) - at)), start + len(data))
        if not more:
            return data, -1
        data += more


def _parse(data: bytes, at: int, end: int) -> tuple[dict[str, str], int, int] | None:
    """Headers, start of the block and its length, if data has a record's header from ``at`` to ``end``."""
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    fields = dict(x.split(": ", 1) for x in data[at + len(MAGIC) : end].decode("utf-8", "replace").split("\r\n") if ": " in x)
    length = fields.get("Content-Length", "")
    return (fields, end + len(END), int(length)) if re.fullmatch(r"[0-9]{1,15}", length) else None


def candidates(blocks: DataFrame, uri: str, block_bytes: int) -> DataFrame:
    """Each place of a block that could start a record: its successor and where the chain from it leaves the block (null: it breaks)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = store(uri)[0]
        for batch in batches:
            for path, size, first in zip(*(batch[c].to_pylist() for c in ("path", "size", "first"))):
                last, found = min(size, first + block_bytes), []
                with fs.open_input_file(path) as file:
                    data = file.read_at(min(size - first, block_bytes + USUAL_HEADER), first)
                    at = data.find(MAGIC)
                    while 0 <= at < last - first:
                        data, end = _header_end(file, data, first, at, size)
                        if parsed := _parse(data, at, end):
                            found.append((first + at, first + parsed[1] + parsed[2] + len(GAP)))
                        at = data.find(MAGIC, at + 1)
                leaves: dict[int, int] = {}
                for offset, successor in reversed(found):
                    leaves[offset] = successor if successor >= last else leaves.get(successor)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([leaves[x[0]] for x in found], pa.int64())], ["path", "offset", "successor", "leaves"])

    return blocks.mapInArrow(scan, "path string, offset long, successor long, leaves long")


def reachable_entries(found: DataFrame, archives: DataFrame, most_blocks: int) -> DataFrame:
    """(path, offset) of the first reachable record that starts in each block, by pointer jumping from offset 0. Where a chain
    points to a place that is no candidate, that place is the last entry of its file."""
    ends = found.filter("leaves is not null").select("path", F.col("leaves").alias("offset")).distinct()
    starts = archives.filter("size > 0").select("path", F.lit(0).cast("long").alias("offset"))
    jump = materialize(found.join(ends.unionByName(starts).distinct(), ["path", "offset"]).select("path", "offset", "leaves"), "jumps")
    reached = starts
    for k in range(max(1, math.ceil(math.log2(max(2, most_blocks))))):
        after = reached.join(jump, ["path", "offset"]).filter("leaves is not null").select("path", F.col("leaves").alias("offset"))
        reached = materialize(reached.unionByName(after).distinct(), "reached")
        if 2 ** (k + 1) < most_blocks:
            further = jump.select("path", F.col("offset").alias("leaves"), F.col("leaves").alias("beyond"))
            jump = materialize(jump.filter("leaves is not null").join(further, ["path", "leaves"]).select("path", "offset", F.col("beyond").alias("leaves")), "jumps")
    return reached


def read_records(entries: DataFrame, uri: str, block_bytes: int, on_break: str = "raise") -> DataFrame:
    """The records that start in the entries' blocks, with digests of the payloads as read.

    A file must be its chain of records from first byte to last. Where no whole record stands at the place that the one before
    points to, the read fails, or with on_break="report" gives a row of type "broken" with the place and the bytes from there
    to the end of the file, none of which are read."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = store(uri)[0]
        for batch in batches:
            for path, size, offset in zip(*(batch[c].to_pylist() for c in ("path", "size", "offset"))):
                rows, start, last = [], offset, min(size, (offset // block_bytes + 1) * block_bytes)
                with fs.open_input_file(path) as file:
                    data = file.read_at(min(size - start, last - start + USUAL_HEADER), start)
                    while offset < last:
                        data, end = _header_end(file, data, start, offset - start, size)
                        parsed = _parse(data, offset - start, end)
                        if parsed is None or start + parsed[1] + parsed[2] + len(GAP) > size:
                            if on_break == "raise":
                                raise ValueError(f"{path}: no whole record at {offset}, {size - offset} bytes unread")
                            rows.append((None, None, size - offset, None, "broken", None, path, offset))
                            break
                        fields, block, length = parsed
                        if block + length > len(data):  # the last record of the block reaches into later ones
                            data += file.read_at(block + length - len(data), start + len(data))
                        head = data.find(END, block, block + length) + len(END)
                        page_id, refers_to = (re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(x, "")) for x in ("WARC-Record-ID", "WARC-Refers-To"))
                        payload = memoryview(data)[head : block + length]
                        full = re.search(rb"Content-Length: ([0-9]+)", data[block:head])
                        own = fields["WARC-Type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        rows.append((page_id and int(page_id[1]), fields["WARC-Target-URI"], len(payload) if own else int(full[1]), digest, fields["WARC-Type"], refers_to and int(refers_to[1]), path, offset))
                        offset = start + block + length + len(GAP)
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORDS.split(", ")]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split(" ")[0] for x in RECORDS.split(", ")])

    return entries.mapInArrow(walk, RECORDS)


def read_archives(archives: DataFrame, block_bytes: int = 4 << 20, on_break: str = "raise") -> DataFrame:
    """All records of archives (path, size); what to do where a chain breaks, see ``read_records``."""
    spark = archives.sparkSession
    uri, (largest,) = shared_dir(spark), archives.agg(F.max("size")).first()
    blocks = archives.filter("size > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(block_bytes))))
    tasks = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(candidates(blocks.repartition(tasks, "path", "first"), uri, block_bytes), "candidates")
    entries = reachable_entries(found, archives, math.ceil((largest or 0) / block_bytes))
    entries = entries.join(archives, "path").filter("offset < size")
    return read_records(entries.repartition(tasks, "path", "offset"), uri, block_bytes, on_break)
