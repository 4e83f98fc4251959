"""Media columns: payloads in tar shards under the digest of their content; rows carry digest, offset and length.

A payload is stored as an 8-bit grey PNG of width 576, which loses nothing. Each task writes shards of its own to the
shared folder and stores a payload once a shard, so a text that a third of all rows repeat costs one entry a shard and
no row is shuffled. The index (one row per document) is a table; metadata columns then come from range reads of the 33
header bytes alone, and features from range reads of whole entries.

Defined results: a null text is the empty one, whose payload is 576 bytes of 255. Repeated rows give repeated rows;
equal texts give equal values. Extra columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RollingFiles, materialize, new_folder, small_batches, store, texts

WIDTH, FILL = 576, b"\xff"
#: Bytes of signature and IHDR chunk; the layout of a PNG file is fixed.
HEADER, SIGNATURE = 33, b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, digest binary, shard string, offset long, length long, n_bytes long"


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of the width."""
    return data + FILL * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A padded payload as PNG: a row of samples for each 576 bytes, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of what ``encode`` gave; every chunk's checksum is verified."""
    at, data, (width, height, *_) = len(SIGNATURE), b"", header(media)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first 33 bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack_from(">IIB", start, 16)


def write_shards(docs: DataFrame, shard_bytes: int = 64 << 20) -> DataFrame:
    """The index of all documents; its payloads lie in tar shards of about ``shard_bytes``."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, there = RollingFiles(folder, ".tar", shard_bytes, end=bytes(1024)), [], {}

        def flush() -> pa.RecordBatch:
            out.close()
            names = [x.split(" ")[0] for x in INDEX.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)
            rows.clear()
            there.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                data = text.as_buffer().to_pybytes()
                payload = pad(data)
                digest = hashlib.sha256(payload).digest()
                if digest not in there:
                    media = encode(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(media)
                    at = out.append(member.tobuf(tarfile.USTAR_FORMAT), media, bytes(-len(media) % 512))
                    there[digest] = (out.path, at + 512, len(media))
                rows.append((doc_id, digest, *there[digest], len(data)))
                if out.full:
                    yield flush()
        if rows:
            yield flush()

    return materialize(texts(docs).mapInArrow(write, INDEX), "media-index")


class _Ranges:
    """Range reads; the last file stays open, as an index lists a shard's entries in their order."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)[0], None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.file, self.path = self.fs.open_input_file(path), path
        return self.file.read_at(length, offset)


def fill_metadata(index: DataFrame, uri: str) -> DataFrame:
    """The index with width, height and bits, from range reads of header bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(uri)
        for batch in batches:
            found = [header(ranges.read(p, o, HEADER)) for p, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist())]
            for k, name in enumerate(("width", "height", "bits")):
                batch = batch.append_column(name, pa.array([x[k] for x in found], pa.int32()))
            yield batch

    return index.mapInArrow(fill, f"{INDEX}, width int, height int, bits int")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(described: DataFrame, uri: str) -> DataFrame:
    """Payload and media digests and a feature string of each row, from the stored bytes.

    The feature is the header's width, height and bits, and of the samples: the sum, the sum of squares, and how many
    differ from the one before them; integers all, so the same everywhere."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(uri)
        for batch in batches:
            known, rows = {}, []
            for r in batch.to_pylist():
                key = r["shard"], r["offset"]
                if key not in known:
                    media = ranges.read(*key, r["length"])
                    payload = decode(media)
                    if hashlib.sha256(payload).digest() != r["digest"]:
                        raise ValueError(f"{key}: the payload is not what its digest says")
                    counts = np.bincount(x := np.frombuffer(payload, np.uint8), minlength=256)
                    values = np.arange(256)
                    feature = f"{r['width']}x{r['height']}x{r['bits']}:{counts @ values}:{counts @ values**2}:{np.count_nonzero(x[1:] != x[:-1])}"
                    known[key] = (len(payload), r["digest"].hex(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append((r["doc_id"], r["n_bytes"], *known[key]))
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [x.split(" ")[0] for x in FEATURES.split(", ")])

    return described.mapInArrow(features, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs, reads them back and returns their features."""
    from .common import shared_dir

    uri = shared_dir(docs.sparkSession)
    return read_features(fill_metadata(write_shards(docs), uri), uri)
