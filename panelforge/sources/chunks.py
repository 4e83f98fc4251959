"""Cached chart payloads as a data source: a partition for each chunk file, replayed in the order of chunks.

A folder holds ``<name>_<label>.json`` for each chunk of a name, labels being its first day (yyyymmdd), and may hold a file
``<name>.json`` of an older layout. Closed chunks never change, so what is cached is what they are. The last chunk is still
open: it is always due again, and until a newer payload is written its file is read, or the older layout's where it has none.
A chunk whose file is missing or is no JSON object is due and gives no rows.

    register(spark)
    spark.read.format("chart_chunks").option("path", uri).option("labels", "20240101,20250101").load()

Rows are (name, label, ts, price, mcap, volume), merged by time within a chunk. Filters on name and label choose partitions,
so that files they exclude are never opened."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "name string, label string, ts timestamp, price double, mcap double, volume double"
SERIES = ("prices", "market_caps", "total_volumes")


@dataclass
class Chunk(InputPartition):
    name: str
    label: str
    path: str


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def plan(files: list[str], labels: list[str], names: list[str] | None = None) -> list[tuple[str, str, str | None, bool]]:
    """(name, label, file, due) of every wanted chunk: the file that is read for it (None: there is none), and whether it is to be
    fetched again."""
    there = set(files)
    names = sorted({f.rsplit("_", 1)[0] if f.rsplit("_", 1)[-1].isdigit() else f for f in there}) if names is None else names
    out = []
    for name in names:
        for label in sorted(labels):
            last = label == max(labels)
            own = f"{name}_{label}" in there
            file = f"{name}_{label}" if own else name if last and name in there else None
            out.append((name, label, file, last or not own))
    return out


def _keeps(filters: list, row: dict[str, str]) -> bool:
    test = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
    return all(test[type(f)](row[f.attribute[0]], f.value) for f in filters)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chart_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.labels = options["path"], [x for x in options["labels"].split(",") if x]
        self.names = options["names"].split(",") if options.get("names") else None
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute in (("name",), ("label",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        wanted = plan(listed(self.uri), self.labels, self.names)
        return [Chunk(name, label, file) for name, label, file, _ in wanted if file and _keeps(self.filters, {"name": name, "label": label})]

    def read(self, partition: Chunk | None) -> Iterator[tuple]:
        if partition is None:  # a folder without chunks
            return
        payload = load(self.uri, partition.path)
        by_time: dict[int, list] = {}
        for k, series in enumerate(SERIES):
            for ts, value in (payload or {}).get(series) or []:
                by_time.setdefault(int(ts), [None] * 3)[k] = None if value is None else float(value)
        from datetime import datetime, timedelta, timezone

        begin = datetime(1970, 1, 1, tzinfo=timezone.utc)
        for ts, values in sorted(by_time.items()):
            yield (partition.name, partition.label, begin + timedelta(milliseconds=ts), *values)


def listed(uri: str) -> list[str]:
    """The names of the JSON files of a folder, without their ending."""
    from pyarrow import fs

    store, base = _store(uri)
    return [f.base_name[:-5] for f in store.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name.endswith(".json")]


def write(payloads: DataFrame, uri: str) -> None:
    """Writes payloads (file, payload) as the folder's JSON files, each by its task, which holds few at a time."""

    def put(rows: Iterator[Row]) -> None:
        store, base = _store(uri)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['file']}.json") as out:
                out.write(row["payload"].encode())

    payloads.select("file", "payload").foreachPartition(put)


def load(uri: str, file: str) -> dict | None:
    store, base = _store(uri)
    try:
        with store.open_input_file(f"{base}/{file}.json") as source:
            found = json.loads(source.read())
    except (ValueError, OSError):
        return None
    return found if isinstance(found, dict) else None


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets the session hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)


def chunks(spark: SparkSession, uri: str, labels: list[str], names: list[str] | None = None) -> DataFrame:
    """Rows of all cached chunks; a time that several chunks have is that of the latest that has it, value by value."""
    register(spark)
    reader = spark.read.format("chart_chunks").option("path", uri).option("labels", ",".join(labels))
    found = (reader.option("names", ",".join(names)) if names else reader).load()
    latest = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("label"))).alias(c) for c in ("price", "mcap", "volume")}
    return found.groupBy("name", "ts").agg(*latest.values())


def due(spark: SparkSession, uri: str, labels: list[str], names: list[str] | None = None) -> DataFrame:
    """(name, label) of the chunks to be fetched: missing and broken ones, and always the last. Each file is opened by a task."""
    rows = [(name, label, file, again) for name, label, file, again in plan(listed(uri), labels, names)]

    def broken(batches):
        for pdf in batches:
            pdf["due"] = [again or load(uri, file) is None for file, again in zip(pdf["file"], pdf["due"])]
            yield pdf[pdf["due"]][["name", "label"]]

    wanted = spark.createDataFrame(rows, "name string, label string, file string, due boolean")
    return wanted.repartition(max(1, len(rows) // 100 + 1)).mapInPandas(broken, "name string, label string")
