"""What the operators of this package share: word definition, shared storage, materialised tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.session import discard, materialize, shared_dir, shared_path  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, as texts may be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the named columns and text, a null text as the empty one."""
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))


def store(uri: str):
    """The pyarrow file system of a folder and the folder's path there; tasks write and range-read with it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class RollingFiles:
    """Appends entries to files of about ``limit`` bytes in a shared folder.

    Each file has a name of its own, so a task that runs again (a lost executor, speculation) never touches a file that
    other rows refer to; what it left unfinished is not referred to by any row."""

    def __init__(self, uri: str, suffix: str, limit: int, end: bytes = b""):
        self.fs, self.base = store(uri)
        self.suffix, self.limit, self.end, self.out = suffix, limit, end, None

    def append(self, *parts: bytes) -> int:
        """Writes the parts and returns the offset of the first one."""
        if self.out is None:
            self.path, self.size = f"{self.base}/{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(self.path)
        at = self.size
        for part in parts:
            self.out.write(part)
            self.size += len(part)
        return at

    @property
    def full(self) -> bool:
        return self.out is not None and self.size >= self.limit

    def close(self) -> None:
        if self.out is not None:
            self.append(self.end)
            self.out.close()
            self.out = None


def new_folder(spark: SparkSession, name: str) -> str:
    path = shared_path(spark, name)
    fs, base = store(path)
    fs.create_dir(base, recursive=True)
    return path
