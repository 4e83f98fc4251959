"""Substring dedup: relative Lempel-Ziv parsing of documents against the whole corpus as reference.

A parse copies the longest phrases that the reference holds. Greedy phrases would depend on which block of the reference
a document meets, and a document would have to meet every block. Here phrases are cut where the text itself says so: a
window of ``window`` words belongs to its anchor, the least hash of the 10-word grams in it, and windows that follow one
another with one anchor form a phrase. Equal windows then lie in phrases with equal anchors in every document, so the
reference is an index by anchor whose blocks are hash partitions, and a document meets just the blocks that can match.

1. Every phrase is looked up whole: if a smaller doc_id has it, it is a factor and all its words are duplicates.
2. At factor boundaries, where an anchor has several different phrases, the windows within those phrases are looked up
   one by one. Each different phrase counts once, for its smallest document.

Both look-ups are aggregations by XXH3 hashes of 128 bits of the contents, with a partial minimum, so a phrase that a
third of all documents share is one row a task. The hash stands for the content: no pair of documents is ever formed.
Anchors only group phrases; different grams with one anchor hash cost time and change no result.

Defined results: a null text is empty: no words, and the digest of the empty string. Texts shorter than a window keep
all. Repeated rows (equal doc_id and text) get equal results and do not remove each other. Rows with a null doc_id
neither remove words nor lose any. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, texts
from .hashing import SpanHash, content_hashes, text_groups

GRAM = 10
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PARSED = "doc_id long, key long, n_words long, whole binary, anchors array<long>, phrases array<binary>, starts array<int>, sizes array<int>"


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with each run of white space as one space; starts and ends of their words in it, and each word's text."""
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[True], space[:-1]]) if len(data) else space
    keep = ~space | ~before
    at = np.concatenate([[0], np.cumsum(keep)])
    start = np.flatnonzero(~space & (before | first[:-1]))
    end = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) if len(data) else space) | ~space & first[1:]) + 1
    return np.where(space, np.uint8(32), data)[keep], at[start], at[end], np.searchsorted(offsets, start, "right") - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, window: int, hasher: SpanHash) -> tuple[np.ndarray, ...]:
    """For each phrase: its text, anchor, first word (of the group), number of windows, and its span of bytes."""
    n = len(starts) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    grams = hasher(data, starts[: len(starts) - GRAM + 1], ends[GRAM - 1 :])
    anchor = sliding_min(grams, window - GRAM + 1)
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 6
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1] + 1) | (anchor[whole[1:]] != anchor[whole[:-1]]) | (text[whole[1:]] != text[whole[:-1]])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(whole)))
    first = whole[at]
    return text[first], anchor[first].view(np.int64), first, size, starts[first], ends[first + size - 1 + window - 1]


def parse(docs: DataFrame, window: int) -> DataFrame:
    """One row a document: words, digest of all of them, and its phrases as arrays."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            parts: list[tuple] = []
            contents: list[bytes] = []
            digests, n_words = [], np.zeros(len(batch), np.int64)
            for row, data, offsets in text_groups(batch["text"]):
                flat, starts, ends, text = word_spans(data, offsets)
                n = len(offsets) - 1
                counts = np.bincount(text, minlength=n)
                n_words[row : row + n] = counts
                base = np.concatenate([[0], np.cumsum(counts)])
                raw = flat.tobytes()
                digests += [hashlib.sha256(raw[starts[a] : ends[b - 1]] if b > a else b"").digest() for a, b in zip(base[:-1].tolist(), base[1:].tolist())]
                who, anchor, first, size, a, b = phrases(flat, starts, ends, text, window, hasher)
                contents += content_hashes(raw, a, b)
                parts.append((who + row, anchor, (first - base[who]).astype(np.int32), size.astype(np.int32)))
            if parts:
                who, anchor, first, size = (np.concatenate(c) for c in zip(*parts))
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(batch)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, c) for c in (pa.array(anchor), pa.array(contents, pa.binary()), pa.array(first), pa.array(size))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(n_words), pa.array(digests, pa.binary()), *lists], [x.split(" ")[0] for x in PARSED.split(", ")])

    return docs.mapInArrow(run, PARSED)


def window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """(hash, doc_id, key, start) of each window in the listed phrases of rows (doc_id, key, text, marks)."""
    schema = "hash binary, doc_id long, key long, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, marks in enumerate(batch["marks"].to_pylist()):
                data = np.frombuffer(batch["text"][k].as_buffer(), np.uint8)
                flat, starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                size = np.array([m["size"] for m in marks])
                first = np.repeat(np.array([m["start"] for m in marks]), size)
                at = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
                hashes = content_hashes(flat.tobytes(), starts[at], ends[at + window - 1])
                same = lambda name: pa.array(np.full(len(at), batch[name][k].as_py(), np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), same("doc_id"), same("key"), pa.array(at.astype(np.int32))], [x.split(" ")[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def remove_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, key, n_removed, kept) of rows (doc_id, key, text, marks), marks the spans of words to remove."""
    schema = "doc_id long, key long, n_removed long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, marks in zip(batch["text"], batch["marks"].to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [m["start"] for m in marks], 1)
                np.add.at(change, [m["start"] + m["size"] for m in marks], -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist()) if not x])).digest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [x.split(" ")[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def duplicate_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """The keyed texts, their parse, (doc_id, key, start, size) of spans of words that a smaller doc_id has, and the tables that
    the spans are read from."""
    keyed = texts(docs).withColumn("key", F.xxhash64("text"))
    parsed = materialize(parse(keyed, window), "parsed")
    found = parsed.filter("doc_id is not null").select("doc_id", "key", F.explode(F.arrays_zip("anchors", "phrases", "starts", "sizes")).alias("p"))
    found = found.select("doc_id", "key", F.col("p.anchors").alias("anchor"), F.col("p.phrases").alias("phrase"), F.col("p.starts").alias("start"), F.col("p.sizes").alias("size"))
    index = materialize(found.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "phrases")
    # Anchors with more than one phrase: there, windows may recur though phrases don't.
    edges = index.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    edges = materialize(edges, "edges")
    marked = index.join(edges.withColumn("edge", F.lit(True)), "anchor", "left").filter("edge or least < most")
    marked = materialize(marked, "marked")
    hits = found.join(marked, ["anchor", "phrase"]).filter("doc_id > least or edge")
    hits = materialize(hits.select("doc_id", "key", "start", "size", (F.col("doc_id") > F.col("least")).alias("copied")), "hits")
    discard(index, edges, marked)
    factors = hits.filter("copied").select("doc_id", "key", "start", (F.col("size") + window - 1).alias("size"))

    marks = hits.filter("not copied").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "size")).alias("marks"))
    windows = materialize(window_hashes(keyed.join(marks, ["doc_id", "key"]).select("doc_id", "key", "text", "marks"), window), "windows")
    again = materialize(windows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"), "again")
    at_edges = windows.join(again, "hash").filter("doc_id > least").select("doc_id", "key", "start", F.lit(window).alias("size"))
    return keyed, parsed, factors.unionByName(at_edges), [hits, windows, again]


def remove_duplicates(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    keyed, parsed, spans, read = duplicate_spans(docs, window)
    marks = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "size")).alias("marks"))
    changed = remove_spans(keyed.join(marks, ["doc_id", "key"]).select("doc_id", "key", "text", "marks")).dropDuplicates(["doc_id", "key"])
    changed = materialize(changed, "changed")
    discard(*read)
    joined = parsed.select("doc_id", "key", "n_words", "whole").join(changed, ["doc_id", "key"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "whole"))).alias("kept_sha256"))
