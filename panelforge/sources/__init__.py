"""Readers and writers: tables, Markdown universes, cached payload chunks, and twin or manifest outputs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.session import replace_folders


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def markdown_universe(spark: SparkSession, path: str) -> DataFrame:
    """(cohort, rank, coin, symbol) from the pipe rows of a Markdown file, the cohort from the heading above; the first
    row of a symbol stays. Lines of one file are numbered within it; universes are small files."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    heading = F.regexp_extract("line", r"^#+\s*(.*\S)\s*$", 1)
    a = lines.withColumn("cohort", F.last(F.when(heading != "", heading), ignorenulls=True).over(W.orderBy("at")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = a.filter(F.trim("line").startswith("|")).select("at", "cohort", cells.alias("c"))
    rows = rows.select("at", "cohort", F.col("c")[0].try_cast("int").alias("rank"), F.element_at("c", -2).alias("coin"), F.upper(F.element_at("c", -1)).alias("symbol")).filter("rank is not null")
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("symbol").orderBy("at"))).filter("_r = 1")
    return first.select("cohort", "rank", "coin", "symbol").orderBy("rank", "symbol")


def pending_chunks(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks to fetch: those not done, and always the last one, which may still be open."""
    last = wanted.agg(F.max("chunk").alias("chunk"))
    return wanted.join(done.select("chunk"), "chunk", "left_anti").unionByName(last).distinct()


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All cached JSON chunks under a folder (chunk=.../...), with a fixed schema."""
    return spark.read.schema(schema).json(path)


def write_twins(df: DataFrame, path: str, **measures: Column) -> dict[str, object]:
    """A table as Parquet and as CSV, and the measures (aggregates, the count as ``rows``) that the write itself took.

    The table is computed once: the CSV is made from the Parquet. Both are written under other names and renamed together, so
    that a failed write leaves the old pair."""
    seen = Observation()
    new = f"{path}.{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())).write.parquet(f"{new}.parquet")
    df.sparkSession.read.schema(df.schema).parquet(f"{new}.parquet").write.option("header", True).csv(f"{new}.csv")
    replace_folders(df.sparkSession, [(f"{new}.{kind}", f"{path}.{kind}") for kind in ("parquet", "csv")])
    return seen.get


def write_manifest(df: DataFrame, path: str) -> None:
    """A one-row result as JSON."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a manifest is one row")
    df.sparkSession.createDataFrame([(json.dumps(row[0].asDict(True), default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
