"""Plain text files as manuscripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import file_title


def read(spark: SparkSession, path: str, glob: str = "*.{txt,md,markdown,TXT,MD}") -> DataFrame:
    """(path, title, text): a row per text file below path, whole; other files are passed over, and so are empty ones, as Spark lists none of length 0.

    The file's name is its title. Bytes that are no UTF-8 become replacement marks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_title(F.substring_index("path", "/", -1)).alias("title"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
