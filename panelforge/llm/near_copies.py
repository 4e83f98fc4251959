"""Near copies for filtering: five-word shingle sets, candidates by MinHash bands, links by exact Jaccard similarity.

Rows whose texts have equal shingle sets are one point. Points that share a band of five minima (30 bands: a pair at
similarity 0.8 shares none with a chance of 7e-6) are candidates. Each candidate pair is either compared by its whole
shingle sets or already known to be in one component: the first round compares a bucket's points with one of them, the
last round all points of a bucket that components still part. There, buckets are cut into blocks and tasks compare two
blocks each, so that no pair is a row and no task holds more than two blocks. A large group of near copies costs a row a
point and band, since the first round joins it.

Defined results: null, empty and blank texts have the empty set and are one point. A text of fewer words than a shingle
is one shingle. Rows are told apart by all their columns (maps are not supported), so null or repeated doc_ids with
different texts are rows of their own; rows that are equal in all columns are one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches
from .components import connected_components
from .hashing import mix

BANDS, ROWS = 30, 5
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of UTF-8 text, A-Z lowered."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[a:b], 5) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima, equal for equal minima of the same band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for part in range(0, len(hashes), 1024):
            least = np.minimum(least, (hashes[None, part : part + 1024] * FACTORS[:, None]).min(1))
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in mix(least).reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signatures(keyed: DataFrame, shingle: int) -> DataFrame:
    """row_key, digest of the shingle set and the band keys of each row."""
    import xxhash

    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes(), shingle) for x in batch["text"]]
            digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            bands = [band_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch["row_key"], pa.array(digests, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["row_key", "digest", "bands"])

    return keyed.select("row_key", "text").mapInArrow(run, "row_key long, digest string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those pairs (a, b) of points whose shingle sets are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"]):
                if a != last:
                    last, own = a, shingle_set(x.as_buffer().to_pybytes(), shingle)
                good.append(similarity(own, shingle_set(y.as_buffer().to_pybytes(), shingle)) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("point").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("point").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def blocks_of(parted: DataFrame, block: int) -> DataFrame:
    """The points (band, n, point, root) of parted buckets, each once for every two blocks of its bucket that hold it."""
    count = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("point"), count).cast("int")
    both = parted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return both.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "point", "root")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """point and shingles, its set as 64-bit numbers, of (point, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes(), shingle).tobytes() for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["point"], pa.array(sets, pa.binary())], ["point", "shingles"])

    return texts.mapInArrow(run, "point long, shingles binary")


def linked_blocks(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different roots that points of (band, low, high, point, root, shingles) join: they share two blocks and are at least so similar."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        used = np.bincount(at)
        dense = np.cumsum(used > 1) - 1  # shingles that one point alone has join nothing
        owner = np.repeat(np.arange(len(sets)), sizes)
        owner, at = owner[used[at] > 1], dense[at[used[at] > 1]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        shared = int(at[-1]) + 1 if len(at) else 0
        width = min(shared, 4096)
        for k in range(0, shared, 4096):
            a, b = np.searchsorted(at, [k, k + 4096])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], at[a:b] - k] = 1
            both += part @ part.T
        root = pdf["root"].to_numpy()
        total = sizes[:, None] + sizes[None, :] - both
        x, y = np.nonzero((both >= least * total) & (root[:, None] < root[None, :]))
        return pd.DataFrame({"a": root[x], "b": root[y]}).drop_duplicates()

    return members.groupBy("band", "low", "high").applyInPandas(link, "a long, b long")


def components(keyed: DataFrame, shingle: int = 5, least: float = 0.8, block: int = 400) -> DataFrame:
    """row_key and component (a row_key) of each of the rows (row_key, text)."""
    prints = materialize(signatures(keyed, shingle), "signatures")
    points = materialize(prints.groupBy("digest").agg(F.min("row_key").alias("point"), F.first("bands").alias("bands")), "points")
    members = points.select("point", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("point").alias("centre"), F.max("point").alias("y"), F.count("*").alias("n")).filter("centre < y")
    members = materialize(members.join(shared.drop("y"), "band"), "members")
    few = members.select(F.col("point").alias("row_key")).distinct()
    texts = materialize(keyed.join(few, "row_key").select(F.col("row_key").alias("point"), "text").dropDuplicates(["point"]), "texts")
    pairs = members.filter("point <> centre").select(F.col("centre").alias("a"), F.col("point").alias("b")).distinct()
    links = materialize(verified(pairs, texts, shingle, least), "links")
    labels = connected_components(links).withColumnRenamed("node", "point")
    # Buckets that components part; points without a link are their own roots.
    rooted = members.join(labels, "point", "left").select("band", "n", "point", F.coalesce("root", "point").alias("root"))
    rooted = materialize(rooted, "rooted")
    parted = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("band")
    rest = materialize(blocks_of(rooted.join(parted, "band"), block), "blocks")
    sets = materialize(shingle_sets(texts.join(rest.select("point").distinct(), "point").select("point", "text"), shingle), "sets")
    found = materialize(linked_blocks(rest.join(sets, "point"), least), "links")
    joined = connected_components(found)
    named = points.select("digest", "point").join(labels, "point", "left").select("digest", F.coalesce("root", "point").alias("root"))
    named = named.join(joined.toDF("root", "top"), "root", "left").select("digest", F.coalesce("top", "root").alias("component"))
    named = materialize(named, "named")
    discard(points, members, texts, links, rooted, rest, sets, found)
    return prints.select("row_key", "digest").join(named, "digest").select("row_key", "component")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """docs with __row_key, a hash of all columns, and __row_check, another one."""
    columns = [F.struct(F.isnull(c), F.col(c)) for c in docs.columns]
    return docs.withColumns({"__row_key": F.xxhash64(*columns), "__row_check": F.xxhash64(F.lit("check"), *columns)})


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component (row_key, component) the row with the smallest doc_id, nulls last; docs have both
    hashes, which go.

    The texts are shuffled once, by the row's key, whatever the sizes; rows equal in all columns meet there. Of 128 bits, as
    with 64 some different rows of a very large table would share a key: these stay if one of them does."""
    ids = docs.select(F.col("__row_key").alias("row_key"), "doc_id").join(found.distinct(), "row_key")
    first = F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "row_key"))
    kept = materialize(ids.groupBy("component").agg(first.alias("first")).select(F.col("first.row_key").alias("__row_key")), "kept")
    return docs.join(kept.hint("merge"), "__row_key", "left_semi").dropDuplicates(["__row_key", "__row_check"]).drop("__row_key", "__row_check")


def keep_one_of_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of near copies, all columns as they are."""
    keyed = keyed_rows(docs)
    return one_of_each(keyed, components(keyed.select(F.col("__row_key").alias("row_key"), F.coalesce("text", F.lit("")).alias("text")), shingle, least))
