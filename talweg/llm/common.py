"""What the operators of this subpackage share: tables, the shared work folder, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER, WHITE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it, a local session (tests) gets one of this
    machine, where driver and executors are one process; on a cluster, whose executors would each write to a disk of their
    own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="talweg-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for the intermediate tables of one run of the operator `name`."""
    return f"{shared_dir(spark)}/talweg-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` as a table written at `path` and read again: the lineage ends there, and lost executors lose nothing of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to 1024 rows and 16 MB, on which the memory of both sides depends; smaller settings stay.
    The plan reads them when it runs, so they stay set."""
    for name, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch of at most 1024 rows; what it returns None for is left out."""
    bounded_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                if (out := each(batch.slice(at, 1024))) is not None:
                    yield out

    return df.mapInArrow(over, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, for whose texts (null: empty) `keep` says so. No row is joined or moved."""
    packed = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1)], names=["row"]).filter(pa.array(keep(batch.column(0).to_pylist()), pa.bool_()))

    return arrow_map(packed, each, T.StructType([packed.schema["row"]])).select("row.*")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, named doc_id (long) and text (null: empty); other columns never clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def crc_mod(key: str, n: int):
    """crc32 of a column as text, modulo n: the split into training and held-out rows. A null key gives null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def crc_mod_py(key: int, n: int) -> int:
    return zlib.crc32(str(key).encode()) % n


class Recent(dict):
    """What `make` gives for a key, remembered: of two generations of at most `most` keys the older one goes."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
