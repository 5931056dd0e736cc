"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def local(name: str = "factweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, as tests and benches use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out by its keys and never sent whole through the driver.

    For tables that grow with the input: Spark guesses exploded rows as one each and written ones by their compressed size, so it
    takes tables of millions of rows for small, and broadcasts them."""
    return df.hint("merge")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table to the folder that all see (spark.checkpoint.dir, or one set here where it is unset, as in tests)
    and read again, so that several uses share one run, which outlives executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = f"file://{tempfile.gettempdir()}/{__package__}-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
