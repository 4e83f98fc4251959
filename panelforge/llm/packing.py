"""Best-fit packing: token pieces into as few sequences as it can, by a configuration linear program.

Whole texts are encoded once, in tasks; what remains of a document is one row a piece. The driver sees the histogram of
piece lengths alone (at most ``capacity`` numbers). Over it, a configuration LP (a variable for each way to fill a
sequence) is solved by multiplicative weights: lengths have prices, a knapsack dynamic program finds the fillings of
greatest price, their variables grow, and the prices of what they cover shrink exponentially. Variables are rounded and
the few pieces left over are packed best-fit decreasing (linear_program.py). The plan, runs of equal-length pieces by
rank, has a size bounded by the histogram's, and each piece finds its place by its rank among pieces of its length.
Ranks are counted in hash buckets, of which each length has as many as its pieces ask for, so that a length which many
copies share is dealt over many tasks and rare lengths cost a row each.

Defined results: null and empty texts are the closing id alone. Repeated rows are packed one by one. Rows with a null
doc_id are packed like others. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, small_batches, texts
from .linear_program import configurations

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length in a bucket, on average, at most.
BUCKET = 1000


#: The tokenizer's byte-level alphabet, a fixed rule: visible Latin-1 bytes stand for themselves, the others are numbered from U+0100.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class WordEncoder:
    """Encodes texts word by word, keeping the ids of words it has met.

    The tokenizer drops white space and never joins what stands on either side of it, so a text's ids are those of its
    words in order; only ASCII white space is split here, other kinds are left to the tokenizer. Words of ASCII and
    Latin-1 letters, which its normaliser only lower-cases, are cut further as its pattern cuts them, so that "Word," and
    "word" share a piece; other words go to it whole."""

    #: Characters whose normal form is their lower case, and the tokenizer's own pattern over them.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, most_words: int = 400_000, most_pieces: int = 600_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.pieces = Tokenizer.from_file(path), {}, {}
        self.most_words, self.most_pieces, self.longest = most_words, most_pieces, longest

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words. Plain pieces go straight to the tokenizer's model, in the alphabet of its byte-level step."""
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        pieces, plain, cut, model, out = self.pieces, self.PLAIN.fullmatch, self.PIECE.findall, self.tokenizer.model.tokenize, {}
        for word in words:
            text = word.decode()
            if plain(text) and "<|" not in text:
                ids = b""
                for piece in cut(text.lower()):
                    if (found := pieces.get(piece)) is None:
                        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LEVEL)
                        found = pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in model(mapped)])
                    ids += found
                out[word] = ids
            else:
                out[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[bytes], group: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers; texts are looked at in groups of about so many bytes."""
        k = 0
        while k < len(texts):
            lists, size = [], 0
            while k < len(texts) and (not lists or size + len(texts[k]) <= group):
                lists.append(texts[k].split())
                size += len(texts[k])
                k += 1
            if len(self.known) > self.most_words:
                self.known.clear()
            known = self.known
            new = {w for found in lists for w in found if w not in known}
            own = self._learn(list(new)) if new else {}
            known.update((w, ids) for w, ids in own.items() if len(w) <= self.longest)
            for found in lists:
                yield b"".join([known[w] if w in known else own[w] for w in found])


def pieces(docs: DataFrame, vocabulary: str, capacity: int, closing: int = 0) -> DataFrame:
    """The pieces of each document: its ids and the closing id, cut every ``capacity``; and a number of each row that no other has."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, names = WordEncoder(vocabulary), np.array([closing], "<u4").tobytes(), [*(x.split(" ")[0] for x in PIECES.split(", ")), "row"]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder([x.as_buffer().to_pybytes() for x in batch["text"]])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names)

    return texts(docs).mapInArrow(cut, f"{PIECES}, row long")


def runs(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan: length, first rank, pieces a sequence, first sequence, offset; sorted by length and rank."""
    rank, rows, sequence = defaultdict(int), [], 0
    for filling, m in configs:
        at = 0
        for s in sorted(filling, reverse=True):
            rows.append((s, rank[s], filling[s], sequence, at))
            rank[s] += filling[s] * m
            at += s * filling[s]
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    rows = materialize(pieces(docs, vocabulary, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    plan = runs(configurations(counts, capacity)[0])

    spread = spark.createDataFrame([(length, -(-int(counts[length]) // BUCKET)) for length in np.flatnonzero(counts).tolist()], "length long, buckets int")
    bucketed = rows.join(F.broadcast(spread), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))  # at most a row a length
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")) - 1
    ranked = bucketed.withColumn("own", own).join(materialize(before, "ranks"), ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            k = rank - run[:, 1]
            batch = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(run[:, 3] + k // run[:, 2]))
            yield batch.append_column("offset", pa.array(run[:, 4] + k % run[:, 2] * length))

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
