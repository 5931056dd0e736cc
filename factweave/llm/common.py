"""What the operators share: their two columns, tables in the shared folder, and reading."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once, by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text under fixed names; other columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores until no column has it, in whatever case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


#: The folder of saved() within a scratch().
_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one set here where it is unset and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = f"file://{tempfile.gettempdir()}/factweave-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table to the shared folder and read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it's on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All that saved() writes inside goes at the end, so results that read it must be written by then."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.pop()
        deleted(spark, folder)


def input_bytes(docs: DataFrame) -> int:
    """A table's bytes, to size partitions by, at least 1: as its files have it, else counted from the texts."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known >= 1 << 50:  # Catalyst's guess where it knows nothing
        known = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, known)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, counting no further than that."""
    return df.limit(rows + 1).count() <= rows
