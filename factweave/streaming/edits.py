"""Edit streams: the latest edit of each scene, and checks of touched scenes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate


def latest(edits: DataFrame) -> DataFrame:
    """(user_id, event_id, ts) of the last edit of each scene, ties to the larger id; works on a batch and, in complete mode, on a stream."""
    last = F.max(F.struct("ts", "event_id")).alias("x")
    return edits.groupBy("user_id").agg(last, F.count("*").alias("n_edits")).select("user_id", F.col("x.event_id").alias("event_id"), F.date_format("x.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "n_edits")


def revalidating(edits: DataFrame, prepared: Callable[[], DataFrame], folder: str, **trigger) -> StreamingQuery:
    """Checks again the scenes (scene_id) of a stream of edits, and no others, against the claims as they are at each micro-batch.

    Each batch writes its scenes and their issues under its own number, over what an earlier try of it left, so a batch that is run
    again after a failure changes nothing. issues_now() reads them; the checkpoint lies beside them.
    """

    def batch(touched: DataFrame, number: int) -> None:
        scenes = touched.select("scene_id").where("scene_id is not null").distinct()
        validate.issues(prepared(), scenes).write.mode("overwrite").parquet(f"{folder}/issues/batch={number}")
        scenes.write.mode("overwrite").parquet(f"{folder}/scenes/batch={number}")

    writer = edits.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def issues_now(spark: SparkSession, folder: str) -> DataFrame:
    """Each scene's issues of the last batch that checked it; one without issues by then has none."""
    last = spark.read.parquet(f"{folder}/scenes").groupBy("scene_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/issues").join(last, ["scene_id", "batch"], "left_semi").drop("batch")
