"""Source divergence audit: which sources of a language differ in their terms, counted by DuckDB in hash shards.

Tasks over documents count terms batch by batch in DuckDB, so that a term leaves a task about once a source. Their counts
are dealt by language and term to shards. There DuckDB adds them up, drops terms of fewer than ``least`` documents and
writes one row a term with its sources and counts; a second pass over that table takes partial sums of pairs of sources.

Only terms that both sources of a pair hold need both counts. With f(p, q) = floor((p - q)**2 / q) and a zero index for
a count of zero, the sum over all kept terms is

    sum over common terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))      from shards
    + sum over the first source's terms of f(p, q0)                           from its histogram of counts
    + sum over the second source's terms of f(p0, q)                          from its histogram of counts
    + (kept terms - terms of the first - terms of the second) * f(p0, q0)

so a shard's work grows with its terms and the pairs of sources that hold them, and never with terms times all sources.
Spark adds the shards' sums and ranks. Each shard sends at most ``ranks`` terms of a group to the ranking.

The list of groups (a row for each language and source) is read by each task from the shared folder: the result has a row
for each pair of them within a language, so it is small beside the result.

Defined results: null text, lang and source are ''. Repeated rows count as documents of their own. Texts without terms, and
languages without kept terms, give pairs of value 0 and no terms. A lone source of a language has no pair. Extra columns are
ignored; an empty table gives an empty result. A sum beyond a long raises an error.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, store

#: Letters of ASCII in lower case, other bytes of ASCII as a space, bytes of other characters as they are.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
TERMS = "lang string, term string, sources array<string>, counts array<long>"
PARTS = "part string, lang string, source string, item string, count long, value decimal(38,0)"
#: Rows of counts that a task gathers before it sends them on.
GATHERED = 400_000

TERMS_OF_BATCH = """
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
FROM (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(string_split(text, ' ')) AS term FROM batch) WHERE term <> '' GROUP BY ALL)
GROUP BY ALL
"""
TERMS_OF_SHARD = """
SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts
FROM (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM rows GROUP BY ALL)
GROUP BY lang, term HAVING sum(docs) >= $least
"""
HELD = f"""
CREATE TABLE held AS
SELECT x.lang, x.term, x.source, c, 1 + ({SCALE}::HUGEINT * (c + 1) // (n + v))::BIGINT AS p, 1 + {SCALE} // (n + v) AS p0,
       1 + ({SCALE}::HUGEINT * (total + 1) // (lang_n + v))::BIGINT AS q
FROM (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS c, list_sum(counts) AS total FROM rows) x JOIN groups USING (lang, source)
"""
PARTS_OF_SHARD = """
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, count(*) AS count, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::DECIMAL(38, 0) AS value
FROM held a JOIN held b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'count', lang, source, NULL, c, count(*)::DECIMAL(38, 0) FROM held GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, 1, f(p, q)::DECIMAL(38, 0) FROM held WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= $ranks
"""


def duck(spill: str):
    """A DuckDB of one thread and bounded memory; what exceeds it goes to the folder, which the task removes."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": spill, "preserve_insertion_order": False})


def folded(column: pa.Array) -> pa.Array:
    """Terms in lower case between spaces, by one pass over the bytes of a string array without nulls."""
    if not len(column):
        return column
    offsets, data = column.buffers()[1], column.buffers()[2]
    return pa.StringArray.from_buffers(len(column), offsets, pa.py_buffer(data.to_pybytes().translate(FOLD) if data else b""), offset=column.offset)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term of a language and source, as far as one task has gathered them."""
    with tempfile.TemporaryDirectory() as spill:
        con, held, rows = duck(spill), [], 0
        for source in batches:
            batch = pa.table({"lang": source["lang"], "source": source["source"], "text": folded(source["text"]), "k": pa.array(range(len(source)))})  # noqa: F841
            held.append(con.sql(TERMS_OF_BATCH).to_arrow_table())
            rows += len(held[-1])
            if rows > GATHERED:
                yield from added(con, held)
                held, rows = [], 0
        if held:
            yield from added(con, held)
        con.close()


def added(con, held: list[pa.Table]) -> list[pa.RecordBatch]:
    rows = pa.concat_tables(held)  # noqa: F841
    return con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL").to_arrow_table().to_batches(50_000)


def share(count: Column | int, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exactly."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (F.col(n) + F.col(v)).cast("decimal(19,0)"))


def excess(p: str, q: str) -> Column:
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def source_divergence(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    spark = docs.sparkSession
    small_batches(spark)
    blank = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")}
    counted = docs.select(*blank.values()).mapInArrow(count_terms, COUNTS)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill:
            con = duck(spill)
            schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
            rows = pa.RecordBatchReader.from_batches(schema, batches)  # noqa: F841
            yield from con.sql(TERMS_OF_SHARD, params={"least": least}).to_arrow_reader(20_000)
            con.close()

    kept = materialize(counted.repartition("lang", "term").mapInArrow(add_up, TERMS), "divergence-terms")
    groups = _groups(docs.select(blank["lang"], blank["source"]).distinct(), kept)
    path = groups.written_to

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        with tempfile.TemporaryDirectory() as spill:
            con, (fs, base) = duck(spill), store(path)
            groups = pq.read_table(base, filesystem=fs)  # noqa: F841
            schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
            rows = pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema) for b in batches))  # noqa: F841
            con.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // q")
            con.execute(HELD)
            yield from con.sql(PARTS_OF_SHARD, params={"ranks": ranks}).to_arrow_reader(20_000)
            con.close()

    parts = materialize(kept.mapInArrow(part_sums, PARTS), "divergence-parts")
    discard(kept)
    pairs = _pairs(groups, parts)
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = "lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)
    return terms.select(*named).unionByName(pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best)).select(*named))


def _groups(occurring: DataFrame, kept: DataFrame) -> DataFrame:
    """Each language and source with n (occurrences of kept terms), lang_n (those of the language) and v (kept terms)."""
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_n"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")}
    return materialize(occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero.values()), "divergence-groups")


def _pairs(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """lang, source, item and the sum over all kept terms, for each two sources of a language."""
    counts = parts.where("part = 'count'").groupBy("lang", "source", "count").agg(F.sum("value").alias("m"))
    held = counts.groupBy("lang", "source").agg(F.sum("m").alias("held"))
    own = groups.where("v > 0").withColumn("p0", share(0, "n", "v"))
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = counts.join(own, ["lang", "source"]).withColumn("p", share(F.col("count"), "n", "v")).join(other, "lang").where("source <> item")
    times = F.col("m").cast("decimal(18,0)")
    met = met.select("lang", "source", "item", (excess("p", "q0").cast("decimal(19,0)") * times).alias("there"), (excess("q0", "p").cast("decimal(19,0)") * times).alias("back"))
    met = met.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    sums = met.select("lang", "source", "item", F.col("there").alias("value")).unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    sums = sums.unionByName(parts.where("part = 'pair'").select("lang", "source", "item", "value"))
    own = own.join(held, ["lang", "source"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    neither = (F.col("v") - F.col("held") - F.col("other_held")).cast("decimal(18,0)") * excess("p0", "q0").cast("decimal(19,0)")
    sums = sums.unionByName(own.join(other, "lang").where("source <> item").select("lang", "source", "item", neither.alias("value")))
    bare = groups.where("v = 0")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    return sums.unionByName(none).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
