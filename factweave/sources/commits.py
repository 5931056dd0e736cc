"""Tables that are written together: a commit of several of them is seen whole or not at all.

A commit writes its rows under a folder of its own, with the keys (scenes, stories) that it replaces, and then one small file,
the commit's entry, by a rename that fails if that number is taken. Readers list the entries and take each key's rows from the last
commit that replaced it, so folders without an entry, left by jobs that died, are never read, and what a commit doesn't touch
keeps its files byte for byte. The name of a save is in its entry: saving it again changes nothing.

Two jobs that enter at the same moment are told apart by that rename, so the folder must be on a file system whose rename never replaces
a file (HDFS and the like); on others, object stores among them, one job at a time must write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a row's key, and of the attempt that wrote it.
KEY, ATTEMPT = "_key", "_attempt"


class Taken(RuntimeError):
    """Another job has committed since this one began."""


class Commits:
    """The tables under a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def entries(self) -> list[dict]:
        """The commits, in order: number, name, attempt, tables and whether it holds all that there was."""
        folder = self._path(f"{self.folder}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder))
        names = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
        found = self.spark.sparkContext.wholeTextFiles(f"{self.folder}/_commits/*.json").collectAsMap() if names else {}  # small files, compacted now and then
        by_name = {k.rsplit("/", 1)[-1]: json.loads(v) for k, v in found.items()}
        return [by_name[n] | {"number": int(n[:-5])} for n in names if n in by_name]

    def _live(self, table: str) -> list[dict]:
        live: list[dict] = []
        for e in self.entries():
            if table in e["tables"]:
                live = [e] if e["whole"] else [*live, e]
        return live

    def read(self, table: str, schema: str) -> DataFrame:
        """The table's rows now. schema: of its columns, for a table that nobody has written."""
        live = self._live(table)
        if not live:
            return self.spark.createDataFrame([], schema)
        number = F.create_map(*[F.lit(x) for e in live for x in (e["attempt"], e["number"])])[F.col(ATTEMPT)]
        paths = lambda what: [f"{self.folder}/{e['attempt']}/{table}/{what}" for e in live]
        rows = self.spark.read.parquet(*paths("rows")).withColumn("_number", number)
        if len(live) > 1:
            last = self.spark.read.parquet(*paths("keys")).withColumn("_number", number).groupBy(KEY).agg(F.max("_number").alias("_number"))
            rows = rows.join(last, [KEY, "_number"], "left_semi")
        return rows.drop(KEY, ATTEMPT, "_number")

    def commit(self, name: str, tables: dict[str, tuple[DataFrame, DataFrame, str]], whole: bool = False, expected: int | None = None) -> bool:
        """Writes tables: name to (rows, keys, the rows' key column); rows replace all that there was of the keys (a table of one column).

        False, and nothing is written, if a commit of this name is there. expected: how many commits the rows were made from; if there
        are more by now, Taken is raised, and the job is to be run again on what they left.
        """
        entries = self.entries()
        if any(e["name"] == name for e in entries):
            return False
        if expected is not None and len(entries) != expected:
            raise Taken(name)
        attempt = uuid.uuid4().hex
        for table, (rows, keys, key) in tables.items():
            folder, tag = f"{self.folder}/{attempt}/{table}", F.lit(attempt)
            rows.withColumns({KEY: F.col(key), ATTEMPT: tag}).write.parquet(f"{folder}/rows")
            keys.toDF(KEY).distinct().withColumn(ATTEMPT, tag).write.parquet(f"{folder}/keys")
        self._enter(len(entries), {"name": name, "attempt": attempt, "tables": sorted(tables), "whole": whole})
        return True

    def _enter(self, number: int, entry: dict) -> None:
        """The entry under its number, written aside first."""
        aside = self._path(f"{self.folder}/_aside/{entry['attempt']}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/_commits"))
        place = self._path(f"{self.folder}/_commits/{number:012}.json")
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            raise Taken(entry["name"])

    def compact(self, schemas: dict[str, tuple[str, str]]) -> None:
        """One commit that holds all rows of the tables (name to schema and key column), so that reading them lists no others. Their files stay, for readers that have begun."""
        n = len(self.entries())
        now = {t: self.read(t, schema) for t, (schema, _) in schemas.items()}
        self.commit(f"compact-{n}", {t: (df, df.select(schemas[t][1]), schemas[t][1]) for t, df in now.items()}, whole=True, expected=n)
